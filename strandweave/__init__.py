"""strandweave: batch analytics over genomic intervals, junctions and copy number, on Spark DataFrames."""
