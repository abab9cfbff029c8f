"""Operators of a training-data pipeline, each a Spark job over documents,
pages, vectors or labels.  Nothing else in the library imports this package;
:mod:`tessera.llm.queries` registers its queries."""
