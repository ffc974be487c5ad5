"""strandflow.functions"""
