"""textloom: a PySpark-native engine for preparing and measuring text corpora.

Every operator is a ``DataFrame -> DataFrame`` function or a ``Column``
builder; the heavy lifting is left to Catalyst (pushdown, pruning,
partial aggregation, whole-stage codegen).  Python runs only inside
Arrow-batched pandas UDFs where Spark has no built-in equivalent.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value inside UDF closures, so
    executors need no installed copy of the package (any session, any
    cluster)."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
