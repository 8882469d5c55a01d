"""slmeval — question-answer preparation and run-cost analytics on Spark.

Layout:
  functions/  Column -> Column expressions (text cleaning, arrays, metrics, formatting)
  operators/  DataFrame -> DataFrame operators (statistics, split, tokens, telemetry)
  sources/    readers and writers (items, run results, counters, memory gauges, frames)
  streaming/  Structured Streaming forms (CPU state, memory, latest reading, incremental runs)
  plans/      the registered query set over the driver tables, with their SQL oracles
"""

__version__ = "0.1.0"
