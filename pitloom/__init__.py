"""pitloom: feature, scoring, publication and monitoring jobs on Spark.

Entry points: ``pitloom.operators.asof.asof_join`` (point-in-time joins),
``pitloom.operators.contracts`` (rule tables and the PASS/BLOCK decision),
``pitloom.sources.publish.publish`` (idempotent publication),
``pitloom.operators.gate`` (promotion gate), ``pitloom.streaming.events`` (event reaction),
``pitloom.plans.lifecycle.run_lifecycle`` (the whole job).
"""

__version__ = "0.1.0"
