"""passagekg: papers -> passages -> triples -> graph -> scores, as Spark DataFrame operators."""

__version__ = "0.1.0"
