import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Where both folders are run, ``import conftest`` is this module.
SF = "/root/testdata/sf0.001"
