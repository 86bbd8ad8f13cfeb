"""yarrow.streaming"""
