"""Sources and sinks: file inventories, catalogue feeds, XML metadata, evidence and plans."""
