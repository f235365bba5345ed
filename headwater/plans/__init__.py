"""headwater.plans"""
