"""starsift.operators"""
