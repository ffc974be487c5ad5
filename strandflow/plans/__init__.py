"""strandflow.plans"""
