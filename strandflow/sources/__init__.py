"""strandflow.sources"""
