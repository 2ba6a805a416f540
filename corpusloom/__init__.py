"""corpusloom: a Spark-native engine for corpora of legal and medical text.

Every operator is a function from DataFrames (or Columns) to DataFrames (or
Columns).  Nothing here runs an action unless its docstring says so.
"""
