"""starsift.sources"""
