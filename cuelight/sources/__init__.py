"""cuelight.sources"""
