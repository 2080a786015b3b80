"""Column functions: sets, numbers, strings, patterns, sequences, times, markup, URLs and geography."""
