"""Sources and sinks: schemas, tables, crawl files, and the adapters that derive domain tables."""
