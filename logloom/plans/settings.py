"""Named mining configurations used by the registered queries."""

# Dataset regexes (P2) for the value-checked events pipeline.  They hold no
# lookaround, so the DuckDB oracle (RE2) reads them exactly as Java does.
EVENTS_REGEX = [r"(\d+\.){3}\d+:\d+", r"/[A-Za-z0-9/]+", r"\b\d{3,}\b"]

# Named, lookaround-free masks for the named-mask and hit-count queries.
NAMED_RULES = [(r"(\d+\.){3}\d+:\d+", "HOSTPORT"), (r"/[A-Za-z0-9/]+", "PATH"), (r"\d+", "NUM")]
