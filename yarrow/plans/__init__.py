"""yarrow.plans"""
