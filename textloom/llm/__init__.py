"""Operators of a large-scale training-data pipeline.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` uses it; general helpers come from the rest of the
package.  Every operator takes any DataFrame with the columns it names, keeps
extra columns out of its way (working columns start with ``tl_``; a result
column replaces an input column of the same name) and states in its docstring
what nulls, empty texts, ties, repeated rows and empty tables give.
"""
