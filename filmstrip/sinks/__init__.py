"""Tables to files: markers, planned actions, run events."""
