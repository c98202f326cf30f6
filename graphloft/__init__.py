"""graphloft: a PySpark-native analytics engine for graphs of software."""
