"""Tables from files: listings, markers, mounts, configuration."""
