"""Keyed-table analytics, graph iteration and iterative learning as Spark DataFrame plans."""
