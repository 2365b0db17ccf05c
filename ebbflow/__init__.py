"""Ebbflow: a changefeed apply engine on PySpark."""
