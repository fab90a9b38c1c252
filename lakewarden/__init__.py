"""lakewarden: a PySpark-native engine for incident telemetry, response plans and their evaluation.

Everything is DataFrame in, DataFrame out.  ``operators`` holds the relational and
domain operators, ``functions`` the column expressions they are made of, ``sources``
the readers and sinks, ``plans`` the named queries, ``streaming`` the Structured
Streaming forms.  ``llm`` is an optional subpackage that nothing else imports.
"""
