"""Graph and hypergraph analytics for source trees and tables, on Spark DataFrames."""
