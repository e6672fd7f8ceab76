"""Jobs that follow new bar files."""
