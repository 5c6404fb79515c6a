"""starsift.functions"""
