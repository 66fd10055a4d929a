"""Plan-building helpers: table access and lineage cuts in the shared folder."""
