"""barlab.functions"""
