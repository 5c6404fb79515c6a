"""starsift.plans"""
