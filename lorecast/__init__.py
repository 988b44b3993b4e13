"""lorecast: a PySpark-native engine for knowledge and memory data.

Text segments, entities, claims, graph relations, embeddings and event logs are plain DataFrames; every operator is a
function DataFrame -> DataFrame or Column -> Column, so that Catalyst plans whole queries.
"""
