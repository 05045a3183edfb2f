"""Sources and sinks: source trees, repository addresses, stored graphs, driver tables."""
