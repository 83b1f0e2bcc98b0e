"""Spark-native operators for catalogues of venues: lookups, slots, ranges, diffs, matching, rules and alerts."""
