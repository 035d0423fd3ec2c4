"""Training-data operators: near and exact dedup, packing, licence scan, line dedup, top-k search,
toxicity, WARC archives, source mixing and token files.  Nothing else in the library imports it."""
