"""storyloom: document retrieval and storyline analytics as Spark DataFrame operators.

Every public operator is a plain function ``DataFrame -> DataFrame`` built from native
Spark expressions, joins, windows and aggregates.  Sub-packages:

* ``functions``  - reusable column expressions (text rules, vector math)
* ``sources``    - readers, writers and adapters from the given tables
* ``operators``  - cleaning, embedding, search, storyline, grounding, evaluation
* ``plans``      - composed end-to-end jobs and the query registry
* ``streaming``  - incremental ingestion with Structured Streaming
"""

__version__ = "0.1.0"
