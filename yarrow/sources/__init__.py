"""yarrow.sources"""
