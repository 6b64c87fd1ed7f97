"""cuelight.functions"""
