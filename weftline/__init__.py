"""weftline: web-graph, keyword and text-search analytics on PySpark."""
