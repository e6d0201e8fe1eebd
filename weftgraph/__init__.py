"""weftgraph: a PySpark-native knowledge-graph analytics engine."""
