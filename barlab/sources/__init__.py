"""barlab.sources"""
