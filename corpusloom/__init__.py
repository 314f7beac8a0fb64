"""corpusloom: document corpora as Spark tables: blocks, chunks, sections, search, graphs and checks."""
