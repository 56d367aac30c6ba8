"""Training-data operators: ten independent Spark jobs over documents and pages.

Nothing outside this folder imports it.  ``registry`` lists its queries.
"""
