"""cuelight.plans"""
