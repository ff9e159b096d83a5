"""cloudframe: point clouds and triangle meshes as Spark DataFrames.

Operators are ``DataFrame -> DataFrame`` functions; those that number rows or iterate write to the
shared folder as they go. Rows carry an explicit ``pid`` because Spark has no row order.
"""
