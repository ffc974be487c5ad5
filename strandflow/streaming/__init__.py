"""strandflow.streaming"""
