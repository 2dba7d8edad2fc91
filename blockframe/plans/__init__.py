"""Planning helpers: session settings, lineage cuts, load-aware routing."""
