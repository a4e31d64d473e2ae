"""Spark jobs that measure what moving deliveries off a public holiday does to customers.

``functions`` holds column expressions, ``operators`` holds ``DataFrame -> DataFrame`` steps,
``plans`` composes them into the five analyses, ``sources`` declares schemas, readers and sinks.
"""
