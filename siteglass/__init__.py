"""Siteglass: audit, score and report on many web sites at once with Spark.

Every public function takes and returns a DataFrame or a Column; nothing is
executed until the caller runs an action.
"""
