"""strandflow.operators"""
