"""Column functions: text keys, sequence numbers, names. Columns in, columns out, all native expressions but one."""
