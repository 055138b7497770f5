"""corpusloom: task-focused sifting of code corpora, written as Spark jobs.

Every operator takes DataFrames and returns DataFrames; nothing here starts a
Spark session.  Sub-packages:

``functions``  column expressions (paths, languages, tokens, locales)
``sources``    readers and writers (table folders, directory scan, job log)
``operators``  imports, resolution, graph, ranking, compression, budgets, reports
``plans``      end-to-end plans and the registered reference queries
``streaming``  the job state machine as a streaming query
``llm``        operators for training data (optional; nothing else imports it)
"""
