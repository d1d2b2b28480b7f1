"""srcloom: source-tree and text-corpus analytics as plain Spark plans."""
