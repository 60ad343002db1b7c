"""wayrisk: a Spark-native engine for risk analytics over routes and news events.

``functions`` holds column expressions, ``operators`` DataFrame operators,
``sources`` readers and writers, ``plans`` composed queries and ``streaming``
the continuous forms.  ``llm`` holds training-data operators; nothing else here
imports it.
"""
