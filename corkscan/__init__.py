"""corkscan: batch search analytics over tables of text records, on PySpark.

``sources``    reading and writing records, query lines and published tables
``functions``  column expressions and Arrow batch helpers
``operators``  one module per family of work: validation, text index, keyword
               search, vector search, partitioned and quantised search, metrics
``plans``      end-to-end jobs: ingest, index build, search
``registry``   the queries and their SQL counterparts on the test tables
"""
