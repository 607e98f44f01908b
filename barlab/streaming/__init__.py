"""barlab.streaming"""
