"""Sources and sinks: the catalog, lenient readers, writers of splits, reports and indexes."""
