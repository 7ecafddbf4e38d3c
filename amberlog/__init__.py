"""amberlog: a Spark-native engine for append logs of structured records.

Tables are append-only logs of typed rows; the newest row of a key is current and a tombstone hides it.  Everything is a DataFrame plan.
"""
