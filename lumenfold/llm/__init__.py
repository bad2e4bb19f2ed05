"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Each operator lives in a module of
its own with a general interface; ``queries`` holds the thin ``opN_<name>``
queries over the tables, ``_text`` the NumPy kernels over Arrow buffers and
``_spark`` what the operators share in Spark (materialised tables, joins that
stand hot keys, connected components).
"""
