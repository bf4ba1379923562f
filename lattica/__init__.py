"""Note analytics on Spark: keywords, links, graphs, search, versions, ingest and export as DataFrame pipelines."""
