"""headwater.operators"""
