"""barlab.plans"""
