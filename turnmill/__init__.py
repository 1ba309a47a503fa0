"""Prepare and evaluate chat-training corpora with Spark DataFrames.

``sources``    records, model files and sinks
``functions``  column builders: text, messages, templates, tokens
``operators``  DataFrame -> DataFrame jobs
``plans``      whole pipelines composed of operators
``streaming``  the same work on Structured Streaming inputs
``queries``    the registered queries over the shared test tables
"""
