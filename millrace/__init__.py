"""Spark-first toolkit for tables, intervals, matrices, sequences, trees and graphs."""
