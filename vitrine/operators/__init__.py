"""Table-in, table-out operators (latest-wins, staging, marts, reads, checks, rules)."""
