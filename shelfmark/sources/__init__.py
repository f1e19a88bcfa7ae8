"""Reading inventories, listings and releases; writing snapshots, exports and logs."""
