"""petrichor: Earth-observation event cubes and keyed time series as Spark jobs.

Operators take DataFrames plus column names and return DataFrames; none of them triggers an action.
"""
