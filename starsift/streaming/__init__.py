"""starsift.streaming"""
