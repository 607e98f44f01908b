"""barlab.operators"""
