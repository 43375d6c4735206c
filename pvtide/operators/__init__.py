"""Jobs of the solar dataset, each a function ``DataFrame -> DataFrame``."""
