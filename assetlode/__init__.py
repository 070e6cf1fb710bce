"""Asset analytics on Spark: duplicates, similarity, technical audits and reports over asset catalogs."""
