"""kvjoin: partitioned equi-joins over key/payload relations, Spark-first."""
