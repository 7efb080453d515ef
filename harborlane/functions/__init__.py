"""Column functions: cron text, time zones, masking, conf documents, URIs, traces."""
