"""Ontology analytics as Spark plans: axioms, expression trees and mentions are DataFrames."""
