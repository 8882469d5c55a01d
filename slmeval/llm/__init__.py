"""Training-data operators: tokens, fingerprints, url rules, WARC archives, line and document
near-duplicates, language identification, mixing, language-model scores and quality rules.

Nothing outside this subpackage imports it. Operators take DataFrames and name their columns;
``queries`` holds the registered queries (digest columns over the operators' real outputs).
"""
