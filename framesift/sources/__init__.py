"""Sources and sinks: delimited records, whole files, binary values."""
