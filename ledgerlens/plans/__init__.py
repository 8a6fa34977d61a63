"""Named pipelines: ingest, quality, detection, views, reports."""
