"""cuelight.streaming"""
