"""Sources and sinks: files, parsers, content store, manifests."""
