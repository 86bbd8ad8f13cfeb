"""yarrow.operators"""
