"""cuelight.operators"""
